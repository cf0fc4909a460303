
from __future__ import annotations

import importlib
import os
import sys
import zlib
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402
from pyspark.sql.types import DateType, DecimalType  # noqa: E402

from sqltwins.sql import SIMPLE_MEASURES, THRESHOLD_MEASURES, build_sql  # noqa: E402
from txnrisk import schema as S  # noqa: E402
from txnrisk.functions.rounding import round_half_up  # noqa: E402
from txnrisk.operators import dims, features, quality  # noqa: E402
from txnrisk.operators import measures as M  # noqa: E402
from txnrisk.operators import significance as A  # noqa: E402
from txnrisk.operators import thresholds as X  # noqa: E402
from txnrisk.plans import customers, increment, portfolio, slices, terminals, trend, triage  # noqa: E402
from txnrisk.plans.report import statistical_results  # noqa: E402
from txnrisk.plans.star import (  # noqa: E402
    VIEW,
    Star,
    clean_for,
    enriched,
    open_published,
    publish,
    star_for,
)
from txnrisk.sources import files, landing, sample_tables  # noqa: E402
from txnrisk.sources.workspace import fresh_path, settled  # noqa: E402
from txnrisk.streaming.landing import land_stream  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

SELECTION = {
    "date": ("2024-01-05", "2024-01-20"),
    "value_segment": [S.SEGMENTS[3], S.SEGMENTS[2]],
    "risk_tier": list(S.RISK_TIERS[:2]),
}
DATES_ONLY = {"date": SELECTION["date"]}
OTHER_COSTS = X.Costs(review=5.0, decline=8.0, recovery=0.9)


def entry(spark: SparkSession) -> DataFrame:
    """Fraud rate and lift per amount band, straight from the raw events."""
    raw = sample_tables.events_as_raw(spark, "/root/testdata/sf0.001")
    banded = features.amount_bands(features.time_features(quality.clean(raw)))
    return portfolio.band_lift(banded)


# --- inputs --------------------------------------------------------------------------------------


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return sample_tables.events_as_raw(spark, folder)


def star_of(spark: SparkSession, folder: str) -> Star:
    return star_for(sample_tables.events_as_raw, spark, folder)


def order_star(spark: SparkSession, folder: str) -> Star:
    """Years of thin days, so no folder per day."""
    return star_for(sample_tables.orders_as_raw, spark, folder, daily_folders=False)


# --- output shaping --------------------------------------------------------------------------------


def shown(df: DataFrame) -> DataFrame:
    """Money as double and calendar days as ISO text at the edge."""
    edge = {DecimalType: "double", DateType: "string"}
    kinds = {f.name: edge[type(f.dataType)] for f in df.schema if type(f.dataType) in edge}
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}) if kinds else df


def digits(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Cut unrounded doubles to a stated number of decimals, so that two engines can be compared."""
    return df.withColumns({c: round_half_up(F.col(c), places) for c in columns})


def on_star(build: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, folder: shown(build(star_of(spark, folder)))


def on_fact(build: Callable[[DataFrame], DataFrame]) -> Query:
    return on_star(lambda star: build(star.fact))


def on_orders(build: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, folder: shown(build(order_star(spark, folder)))


def observed_audit(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """T3 gathered while the cleaned rows are written, without a scan of its own."""
    from pyspark.sql import Observation

    seen = Observation("audit")
    raw = raw_events(spark, folder)
    cleaned = quality.positive_amounts(quality.keep_first(typed(with_gaps(raw) if gaps else raw), seen))
    files.write_parquet(cleaned, fresh_path(spark, "clean"))
    return quality.observed_audit(spark, seen)


def on_raw(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: shown(build(raw_events(spark, folder)))


def on_clean(build: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    def run(raw: DataFrame) -> DataFrame:
        return build(quality.clean(raw)).select("transaction_id", *columns)

    return on_raw(run)


def on_staged(build: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    """Running columns look at their rows twice, so they start from the staged clean table."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = clean_for(sample_tables.events_as_raw, spark, folder)
        return shown(build(rows).select("transaction_id", *columns))

    return run


def typed(raw: DataFrame) -> DataFrame:
    return quality.typed(quality.rename_and_prune(raw))


def with_gaps(raw: DataFrame) -> DataFrame:
    """Events of which some lack a time or an amount and a third has an amount of zero or less."""
    i = F.col("TRANSACTION_ID")
    amount = F.when(i % 3 == 0, -F.col("TX_AMOUNT")).when(i % 3 != 1, F.col("TX_AMOUNT")).otherwise(0.0)
    amount = F.when(i % 6 == 1, F.col("TX_AMOUNT")).otherwise(amount)
    return raw.withColumns(
        {
            "TX_AMOUNT": F.when(i % 101 != 0, amount),
            "TX_DATETIME": F.when(i % 97 != 0, F.col("TX_DATETIME")),
        }
    )


def on_gaps(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: shown(build(typed(with_gaps(raw_events(spark, folder)))))


def on_lineitem(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: shown(build(typed(sample_tables.lineitem_as_raw(spark, folder))))


# --- queries --------------------------------------------------------------------------------------


def _cleaning() -> dict[str, Query]:
    return {
        "t01_rename_prune": on_raw(quality.rename_and_prune),
        "t02_typed": on_raw(typed),
        "t03_quality_audit": on_raw(lambda raw: quality.audit(typed(raw))),
        "t03_observed_audit": observed_audit,
        "t03_observed_audit_gaps": lambda spark, folder: observed_audit(spark, folder, gaps=True),
        "t03_quality_audit_lineitem": on_lineitem(quality.audit),
        "t04_keep_first": on_raw(lambda raw: quality.keep_first(typed(raw))),
        "t04_keep_first_lineitem": on_lineitem(quality.keep_first),
        "t05_positive_amounts": on_raw(quality.clean),
        "t03_quality_audit_gaps": on_gaps(quality.audit),
        "t04_keep_first_gaps": on_gaps(quality.keep_first),
        "t05_positive_amounts_gaps": on_gaps(quality.clean_typed),
        "t06_date_key_hour": on_clean(features.time_features, "date_key", "txn_hour"),
        "t07_part_of_day": on_clean(features.time_features, "txn_hour", "part_of_day"),
        "t08_amount_band": on_clean(features.amount_bands, "amount", "amount_band"),
        "t09_customer_sequence": on_staged(features.customer_history, "customer_id", "cust_txn_seq"),
        "t10_minutes_since_previous": on_staged(
            features.customer_history, "customer_id", "mins_since_prev_txn"
        ),
        "t11_expanding_mean": on_staged(
            features.customer_history, "customer_id", "cust_avg_amount_todate"
        ),
        "t12_ratio_to_baseline": on_staged(
            features.customer_history, "customer_id", "amount_vs_cust_avg"
        ),
        "t13_terminal_sequence": on_staged(
            features.terminal_sequence, "terminal_id", "terminal_txn_seq"
        ),
        "t13_terminal_sequence_by_time": on_staged(
            lambda rows: features.terminal_sequence(rows, order="time"),
            "terminal_id",
            "terminal_txn_seq",
        ),
        "t14_fraud_type": on_clean(features.fraud_types, "fraud_scenario", "fraud_type"),
        "t15_time_sorted": on_fact(features.time_sorted),
        "t16_clean_summary": on_raw(
            lambda raw: digits(quality.clean_summary(quality.clean(raw)), 6, "fraud_rate_pct")
        ),
    }


def _dimensions() -> dict[str, Query]:
    return {
        "d01_dim_date": on_fact(dims.build_dim_date),
        "d02_customer_totals": on_fact(dims.customer_totals),
        "d03_dim_customer": on_fact(dims.build_dim_customer),
        "d04_dim_terminal": on_fact(dims.build_dim_terminal),
        "d05_risk_tier": on_fact(
            lambda fact: dims.build_dim_terminal(fact).select(
                "terminal_id", "fraud_rate_pct", "risk_tier"
            )
        ),
        "d06_dim_amount_band": on_fact(dims.build_dim_amount_band),
        "d06_dim_amount_band_orders": on_orders(lambda s: dims.build_dim_amount_band(s.fact)),
    }


def _round_trips() -> dict[str, Query]:
    def daily_scan(spark, folder):
        inbox = fresh_path(spark, "daily")
        files.write_daily_files(raw_events(spark, folder), inbox)
        return _raw_columns(files.read_daily_files(spark, inbox))

    def landing_twice(spark, folder):
        target = fresh_path(spark, "landing")
        raw = raw_events(spark, folder)
        landing.land_new_days(raw.where(F.col("TX_DATETIME") < "2024-01-16"), target)
        landing.land_new_days(raw, target)
        landing.land_new_days(raw, target)
        return _raw_columns(landing.read_landed(spark, target))

    def daily_scan_csv(spark, folder):
        inbox = fresh_path(spark, "daily_csv")
        names = S.RAW.fieldNames()
        shuffled = raw_events(spark, folder).select(*names[3:], *names[:3])  # bound by header
        files.write_csv(shuffled, inbox)
        scanned = files.read_daily_files(spark, inbox, "csv").select(names)
        return shown(typed(scanned))

    def text_ids(spark, folder):
        inbox = fresh_path(spark, "daily_text")
        raw = raw_events(spark, folder)
        as_text = {c: F.col(c).cast("string") for c in ("CUSTOMER_ID", "TERMINAL_ID")}
        files.write_daily_files(raw.withColumns(as_text), inbox)
        return shown(typed(files.read_daily_files(spark, inbox).select(S.RAW.fieldNames())))

    def mixed_days(spark, folder):
        """Days up to the middle with number ids, later days with text ids, one scan."""
        inbox = fresh_path(spark, "daily_mixed")
        raw = raw_events(spark, folder)
        later = F.col("TX_DATETIME") >= "2024-01-16"
        as_text = {c: F.col(c).cast("string") for c in ("TRANSACTION_ID", "CUSTOMER_ID", "TERMINAL_ID")}
        files.write_daily_files(raw.where(~later | F.col("TX_DATETIME").isNull()), inbox)
        files.write_daily_files(raw.where(later).withColumns(as_text), inbox)
        return shown(typed(files.read_daily_files(spark, inbox).select(S.RAW.fieldNames())))

    def mixed_csv(spark, folder):
        """CSV days in two column orders, each bound by its own header."""
        inbox = fresh_path(spark, "daily_csv_mixed")
        names = S.RAW.fieldNames()
        raw = raw_events(spark, folder)
        later = F.col("TX_DATETIME") >= "2024-01-16"
        files.write_csv(raw.where(~later | F.col("TX_DATETIME").isNull()), f"{inbox}/early")
        files.write_csv(raw.where(later).select(*names[::-1]), f"{inbox}/late")
        return shown(typed(files.read_daily_files(spark, inbox, "csv").select(names)))

    def undated_thrice(spark, folder):
        target = fresh_path(spark, "landing")
        missing = F.when(F.col("TRANSACTION_ID") % 97 != 0, F.col("TX_DATETIME"))
        raw = raw_events(spark, folder).withColumn("TX_DATETIME", missing)
        for _ in range(3):
            landing.land_new_days(raw, target)
        return _raw_columns(landing.read_landed(spark, target))

    def quarantined(spark, folder):
        amount = F.when(F.col("TRANSACTION_ID") % 89 == 0, "5x0").otherwise(F.col("TX_AMOUNT").cast("string"))
        raw = raw_events(spark, folder).withColumn("TX_AMOUNT", amount)
        kept, aside = quality.typed_with_quarantine(quality.rename_and_prune(raw))
        states = [rows.select("transaction_id", F.lit(name).alias("state")) for rows, name in ((kept, "kept"), (aside, "set aside"))]
        return states[0].unionByName(states[1])

    def landing_replaced(spark, folder):
        target = fresh_path(spark, "landing")
        raw = raw_events(spark, folder)
        landing.replace_days(raw, target)
        landing.replace_days(raw.where(F.col("TX_DATETIME") >= "2024-01-16"), target)
        return _raw_columns(landing.read_landed(spark, target))

    def landing_streamed(spark, folder):
        base = fresh_path(spark, "stream")
        files.write_daily_files(raw_events(spark, folder), f"{base}/inbox")
        for _ in range(2):  # the second run finds nothing new
            land_stream(spark, f"{base}/inbox", f"{base}/landed", f"{base}/progress")
        return _raw_columns(landing.read_landed(spark, f"{base}/landed"))

    def landing_mixed(spark, folder):
        """Stream, batch, stream into one folder, the last stream batch replayed after a failure."""
        base = fresh_path(spark, "mixed")
        raw = raw_events(spark, folder)
        early, late = raw.where(F.col("TX_DATETIME") < "2024-01-16"), raw.where(F.col("TX_DATETIME") >= "2024-01-16")
        files.write_daily_files(early, f"{base}/inbox")
        land_stream(spark, f"{base}/inbox", f"{base}/landed", f"{base}/progress")
        landing.land_new_days(raw, f"{base}/landed")  # only the later days are new to it
        files.write_daily_files(late, f"{base}/inbox")  # the same rows again, as files
        land_stream(spark, f"{base}/inbox", f"{base}/landed", f"{base}/progress")
        landing.land_batch(late, f"{base}/landed", "stream-replayed")
        return _raw_columns(landing.read_landed(spark, f"{base}/landed"))

    def fact_parquet(spark, folder):
        target = fresh_path(spark, "fact")
        files.write_fact(star_of(spark, folder).fact, target)
        return shown(files.read_fact(spark, target))

    def csv_of(pick, schema):
        def run(spark, folder):
            target = fresh_path(spark, "csv")
            files.write_csv(pick(star_of(spark, folder)), target)
            return shown(files.read_csv(spark, target, schema))

        return run

    def csv_made(make):
        def run(spark, folder):
            made = make(star_of(spark, folder))
            target = fresh_path(spark, "csv")
            files.write_csv(made, target)
            return shown(files.read_csv(spark, target, made.schema))

        return run

    def csv_audit(spark, folder):
        made = quality.audit(typed(raw_events(spark, folder)))
        target = fresh_path(spark, "csv")
        files.write_csv(made, target)
        return files.read_csv(spark, target, made.schema)

    def json_results(spark, folder):
        target = fresh_path(spark, "json")
        result = statistical_results(star_of(spark, folder).fact)
        files.write_json(result, target)
        back = files.read_json(spark, target, result.schema)
        return back.select(
            "test1_amount.u_statistic",
            round_half_up(F.col("test2_timing.chi2"), 6).alias("chi2_timing"),
            round_half_up(F.col("test3_amount_band.chi2"), 6).alias("chi2_band"),
            "test4_fraud_rate_ci.successes",
            "test5_threshold.optimal_threshold",
            "test5_threshold.net_benefit",
            F.size("test6_sensitivity.scenarios").alias("scenarios"),
            F.concat_ws("-", F.transform("test6_sensitivity.threshold_range", lambda v: v.cast("string"))).alias(
                "threshold_range"
            ),
            "test6_sensitivity.stable",
            F.map_values("test2_timing.fraud_rate_by_period")[0].alias("first_period_rate"),
            round_half_up(F.col("test3_amount_band.strength_vs_timing"), 6).alias("strength_vs_timing"),
            "test5_threshold.assumptions.cost_per_review",
            "test5_threshold.assumptions.cost_false_decline",
            "test5_threshold.assumptions.recovery_rate",
            "test7_blind_spot.frauds_missed",
            F.size("test7_blind_spot.by_type").alias("types_missed"),
        )

    def catalog_scan(spark, folder):
        location = fresh_path(spark, "warehouse")
        name = f"txnrisk_{zlib.crc32(location.encode()):08x}"
        spark.sql(f"CREATE DATABASE {name} LOCATION '{location}'")
        try:
            publish(star_of(spark, folder), name)
            scanned = settled(shown(open_published(spark, name).fact))
        finally:
            spark.sql(f"DROP DATABASE {name} CASCADE")
        return scanned

    def terminal_lookup(spark, folder):
        """The rows of the 15 terminals with the most fraud loss, from the terminal-ordered copy."""
        star = star_of(spark, folder)
        target = fresh_path(spark, "by_terminal")
        files.write_terminal_copy(star.fact, target)
        worst = star.terminal.orderBy(F.desc("fraud_volume"), "terminal_id").limit(15)
        wanted = [r["terminal_id"] for r in worst.collect()]  # a list of 15, pushed to the scan as In
        return shown(files.read_fact(spark, target).where(F.col("terminal_id").isin(wanted)))

    def catalog_view(spark, folder):
        """The enriched view published to the catalog, read by another session of it."""
        location = fresh_path(spark, "warehouse")
        name = f"txnrisk_{zlib.crc32(location.encode()):08x}"
        spark.sql(f"CREATE DATABASE {name} LOCATION '{location}'")
        try:
            publish(star_of(spark, folder), name)
            other = spark.newSession()
            seen = settled(shown(other.table(f"{name}.{VIEW}")))
        finally:
            spark.sql(f"DROP DATABASE {name} CASCADE")
        return seen

    def star_sizes(spark, folder):
        counts = [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in star_of(spark, folder).tables().items()
        ]
        first, *rest = counts
        for other in rest:
            first = first.unionByName(other)
        return first

    def star_increment(spark, folder):
        """Half the days built, the rest landed later with the last built day again (replaced)."""
        rows = clean_for(sample_tables.events_as_raw, spark, folder)
        day = F.to_date("txn_datetime")
        middle = rows.select(F.percentile(F.unix_date(day), 0.5).cast("int").alias("d")).first()["d"]
        target = fresh_path(spark, "star")
        increment.build_with_states(settled(rows.filter(F.unix_date(day) <= middle)), target)
        later = rows.filter(F.unix_date(day) >= middle)
        return shown(increment.extend_star(settled(later), target).fact)

    def slice_read(spark, folder):
        target = fresh_path(spark, "slice")
        made = slices.daily_slice(star_of(spark, folder).fact)
        as_text = made.withColumn("txn_date", F.col("txn_date").cast("string"))
        files.write_csv(as_text, target)
        return shown(files.read_slice(spark, target, as_text.schema))

    return {
        "s01_daily_scan": daily_scan,
        "s01_daily_scan_csv": daily_scan_csv,
        "s01_daily_scan_text_ids": text_ids,
        "s01_daily_scan_mixed": mixed_days,
        "s01_daily_scan_mixed_csv": mixed_csv,
        "s02_landing_null_time": undated_thrice,
        "s02_landing_mixed": landing_mixed,
        "t02_quarantine": quarantined,
        "s02_landing": landing_twice,
        "s02_landing_replace": landing_replaced,
        "s02_landing_stream": landing_streamed,
        "s03_fact_parquet": fact_parquet,
        "s04_csv_round_trip": csv_of(lambda star: star.customer, S.DIM_CUSTOMER),
        "s04_csv_dim_date": csv_of(lambda star: star.date, S.DIM_DATE),
        "s04_csv_dim_terminal": csv_of(lambda star: star.terminal, S.DIM_TERMINAL),
        "s04_csv_dim_amount_band": csv_of(lambda star: star.band, S.TABLES["dim_amount_band"]),
        "s04_csv_sweep": csv_made(lambda star: X.threshold_sweep(star.fact)),
        "s04_csv_sensitivity": csv_made(lambda star: X.sensitivity(star.fact)),
        "s04_csv_audit": csv_audit,
        "s05_fact_csv": csv_of(lambda star: star.fact, S.FACT),
        "s06_json_results": json_results,
        "s07_table_scan": catalog_scan,
        "s08_star_build": star_sizes,
        "s08_star_increment": star_increment,
        "s09_constraints": on_star(lambda star: quality.constraint_report(star.tables())),
        "s10_enriched_view": on_star(enriched),
        "s10_catalog_view": catalog_view,
        "s03_terminal_lookup": terminal_lookup,
        "s11_slice_reader": slice_read,
    }


def _raw_columns(df: DataFrame) -> DataFrame:
    return quality.rename_and_prune(df.select(S.RAW.fieldNames()))


def _questions() -> dict[str, Query]:
    def weekly(star, split_years=False):
        moved = trend.weekly_movement(star.fact, star.date, split_years)
        return moved.withColumn("prev_week_fraud", F.col("prev_week_fraud").cast("double"))

    return {
        "q01_portfolio_totals": on_star(lambda s: portfolio.totals_from_dimensions(s.customer, s.terminal)),
        "q02_class_profile": on_fact(portfolio.class_profile),
        "q03_loss_by_type": on_fact(portfolio.loss_by_type),
        "q04_band_lift": on_fact(portfolio.band_lift),
        "q04_band_lift_orders": on_orders(lambda s: portfolio.band_lift(s.fact)),
        "q05_band_coverage": on_fact(portfolio.band_coverage),
        "q06_hourly_rate": on_fact(portfolio.hourly_rate),
        "q07_weekday_rate": on_star(lambda s: portfolio.weekday_rate(s.fact, s.date)),
        "q08_terminal_worklist": on_star(lambda s: terminals.worklist(s.terminal)),
        "q09_concentration": on_star(lambda s: terminals.concentration(s.terminal)),
        "q10_tier_queues": on_star(lambda s: terminals.tier_queues(s.terminal)),
        "q11_attack_windows": on_fact(terminals.attack_windows),
        "q11_attack_windows_top3": on_fact(lambda fact: terminals.attack_windows(fact, limit=3)),
        "q12_segment_risk": on_star(lambda s: customers.segment_risk(s.customer)),
        "q13_baseline_ratio": on_fact(customers.baseline_ratio),
        "q14_repeat_victims": on_star(lambda s: customers.repeat_victims(s.customer)),
        "q15_velocity": on_fact(customers.velocity),
        "q16_daily_trend": on_fact(trend.daily_trend),
        "q17_weekly_movement": on_star(weekly),
        "q17_weekly_movement_orders": on_orders(weekly),
        "q17_weekly_movement_by_iso_year": on_orders(lambda s: weekly(s, split_years=True)),
        "q18_alert_days": on_fact(trend.alert_days),
        "q18_alert_days_one_sigma": on_fact(lambda fact: trend.alert_days(fact, k_sigma=1)),
        "q19_review_simulation": on_fact(X.review_simulation),
        "q20_layered_rules": on_fact(triage.layered_rules),
        "q21_missed_by_amount": on_fact(triage.missed_by_amount),
        "q22_triage_list": on_star(lambda s: customers.triage_list(s.customer)),
        "q23_detection_latency": on_star(lambda s: terminals.detection_latency(s.fact, s.terminal)),
        "q24_heat_map": on_fact(portfolio.heat_map),
        "q25_headline": on_star(lambda s: portfolio.headline(s.fact, s.terminal, s.customer)),
    }


def _significance() -> dict[str, Query]:
    def chi(dimension):
        return on_fact(
            lambda fact: digits(
                A.chi_square(fact, dimension, with_p=False).select(
                    "dimension", "chi2", "dof", "min_expected", "valid"
                ),
                6,
                "chi2",
                "min_expected",
            )
        )

    def chi_p(dimension):
        columns = ("dimension", "dof", "p_value", "significant_at_5pct")
        return on_fact(lambda fact: digits(A.chi_square(fact, dimension).select(*columns), 9, "p_value"))

    def wilson(by=()):
        columns = ("point_estimate_pct", "ci_lower_pct", "ci_upper_pct")
        return on_fact(lambda fact: digits(A.wilson_interval(fact, by), 9, *columns))

    return {
        "a01_class_summary": on_fact(
            lambda fact: digits(
                A.class_summary(fact), 6, "mean_fraud", "mean_legit", "ratio_of_means"
            )
        ),
        "a02_skewness": on_fact(lambda fact: digits(A.skew_by_class(fact), 6, "skew")),
        "a03_normality": on_fact(
            lambda fact: digits(digits(A.normality(fact, draws=None), 3, "k2"), 9, "p_value")
        ),
        "a03_normality_sampled": on_fact(
            lambda fact: digits(digits(A.normality(fact), 3, "k2"), 9, "p_value")
        ),
        "a04_mann_whitney": on_fact(
            lambda fact: A.mann_whitney(fact, with_p=False).select("u_statistic")
        ),
        "a04_mann_whitney_p": on_fact(
            lambda fact: digits(A.mann_whitney(fact), 9, "effect_size_rank_biserial", "p_value")
        ),
        "a05_rank_biserial": on_fact(
            lambda fact: digits(
                A.mann_whitney(fact, with_p=False).select("effect_size_rank_biserial"),
                9,
                "effect_size_rank_biserial",
            )
        ),
        "a06_chi_square_part_of_day": chi("part_of_day"),
        "a06_chi_square_amount_band": chi("amount_band"),
        "a06_chi_square_part_of_day_p": chi_p("part_of_day"),
        "a06_chi_square_amount_band_p": chi_p("amount_band"),
        "a07_association_strength": on_fact(
            lambda fact: digits(
                digits(A.association_strength(fact), 6, "chi2", "strength_vs_first"), 9, "cramers_v"
            )
        ),
        "a08_rate_by_period": on_fact(A.rate_by),
        "a09_wilson_interval": wilson(),
        "a09_wilson_by_period": wilson(["part_of_day"]),
    }


def _decisions() -> dict[str, Query]:
    def cost_model(fact):
        model = X.net_benefit(F.lit(2.0), F.lit(20.0), F.lit(0.6))
        return X.sweep_totals(fact).select(
            "threshold", *[round_half_up(v, 4).alias(k) for k, v in model.items()]
        )

    def best(fact):
        return X.optimum(X.threshold_sweep(fact))

    def live(fact):
        everything = fact.agg(F.sum(F.col("is_fraud").cast("bigint")))
        return X.recost(X.threshold_sweep(fact), everything, OTHER_COSTS)

    def chosen(fact):
        columns = ("op_cost_live", "prevented_live", "net_live", "optimum_net")
        return digits(X.chosen_setting(live(fact), 247), 4, *columns)

    return {
        "x01_threshold_sweep": on_fact(X.threshold_sweep),
        "x02_cost_model": on_fact(cost_model),
        "x03_optimum": on_fact(best),
        "x04_sensitivity": on_fact(X.sensitivity),
        "x05_stability": on_fact(lambda fact: X.stability(X.sensitivity(fact))),
        "x06_sensitivity_pivot": on_fact(lambda fact: X.sensitivity_pivot(X.sensitivity(fact))),
        "x07_blind_spot": on_fact(
            lambda fact: digits(X.blind_spot(fact, best(fact)), 9, "pct_of_all_fraud_missed")
        ),
        "x07_blind_spot_by_type": on_fact(lambda fact: X.blind_spot_by_type(fact, best(fact))),
        "x08_live_recost": on_fact(
            lambda fact: digits(live(fact), 4, "op_cost_live", "prevented_live", "net_live")
        ),
        "x08_chosen_setting": on_fact(chosen),
    }


def _measures() -> dict[str, Query]:
    def simple(name, by):
        keys = [c.strip() for c in by.split(",")]

        def build(star):
            out = M.evaluate(star, [name], by=keys)
            return digits(out, 9, name) if dict(out.dtypes)[name] == "double" else out

        return on_star(build)

    def lifted(names, by, filters=None, **options):
        return on_star(
            lambda star: digits(
                M.evaluate(star, names, by=by, filters=filters, **options), 9, *names
            )
        )

    def by_threshold(*names):
        def build(star):
            table = M.threshold_measures(star, (100, 200, 400), by=["risk_tier"])
            out = table.select("risk_tier", "selected_threshold", *names)
            cut = [n for n in names if n in ("recall_pct", "precision_pct")]
            out = digits(out, 9, *cut) if cut else out
            return digits(out, 6, "net_benefit") if "net_benefit" in names else out

        return on_star(build)

    def previous_month(*names):
        def build(star):
            out = M.previous_month_loss(star).select("year", "month_no", *names)
            return digits(out, 9, *names) if names == ("fraud_loss_mom_pct",) else out

        return build

    def rolling(star, filters=None):
        return digits(M.rolling_rate(star, filters), 9, "fraud_rate_7d_ma")

    def pareto(name):
        keep = ["fraud_loss", name] if name == "terminal_loss_rank" else [name]
        return on_star(lambda s: M.terminal_pareto(s).select("terminal_id", *keep))

    def selections(star):
        """The selected threshold when none, one and several of the data's hundreds are chosen."""
        whole = F.floor(F.col("amount") / 100).cast("int") * 100
        present = star.fact.select(whole.alias("threshold")).where("threshold > 0").distinct()
        chosen = {"none": "threshold < 0", "one": "threshold = 100", "several": "threshold <= 200"}
        picked = [
            M.selected_threshold(present.where(rule)).select(F.lit(k).alias("options"), "selected_threshold")
            for k, rule in chosen.items()
        ]
        return picked[0].unionByName(picked[1]).unionByName(picked[2])

    found = {key: simple(name, by) for key, (name, _, by) in SIMPLE_MEASURES.items()}
    found["m24_selection_rule"] = on_star(selections)
    # approximate by design (HLL sketches per day and class): no SQL twin, held within error by a test
    found["m17_sketch"] = on_star(lambda star: M.affected_from_sketches(settled(M.sketch_slice(star.fact))))
    found |= {key: by_threshold(name) for key, name in THRESHOLD_MEASURES.items()}
    found |= {
        "m10_portfolio_rate": lifted(
            ["fraud_rate_pct", "portfolio_fraud_rate_pct"], ["risk_tier"], SELECTION
        ),
        "m10_portfolio_rate_all_dates": lifted(
            ["portfolio_fraud_rate_pct"], ["risk_tier"], SELECTION, keep_date_filter=False
        ),
        "m10_portfolio_rate_by_week": lifted(
            ["fraud_rate_pct", "portfolio_fraud_rate_pct"], ["week_no", "value_segment"]
        ),
        "m11_risk_lift": lifted(["risk_lift"], ["risk_tier"], SELECTION),
        "m12_risk_lift_label": on_star(
            lambda s: M.evaluate(s, ["risk_lift_label"], by=["terminal_id"])
        ),
        "m13_fraud_loss_previous_month": on_star(previous_month("fraud_loss", "fraud_loss_pm")),
        "m13_fraud_loss_previous_month_orders": on_orders(
            previous_month("fraud_loss", "fraud_loss_pm")
        ),
        "m14_fraud_loss_mom": on_star(previous_month("fraud_loss_mom_pct")),
        "m14_fraud_loss_mom_orders": on_orders(previous_month("fraud_loss_mom_pct")),
        "m15_fraud_rate_7d": on_star(rolling),
        "m15_fraud_rate_7d_orders": on_orders(rolling),
        "m15_fraud_rate_7d_filtered": on_star(
            lambda s: rolling(s, {**DATES_ONLY, "terminal_id": [3, 23]})
        ),
        "m16_running_loss": on_star(lambda s: M.running_loss(s, DATES_ONLY)),
        "m20_high_risk_terminals": on_star(M.high_risk_terminals),
        "m21_terminal_loss_rank": pareto("terminal_loss_rank"),
        "m22_cumulative_loss": pareto("cumulative_loss"),
        "m23_cumulative_loss_pct": on_star(
            lambda s: digits(
                M.terminal_pareto(s).select("terminal_id", "cumulative_loss_pct"),
                9,
                "cumulative_loss_pct",
            )
        ),
        "m24_selected_threshold": on_star(
            lambda s: M.threshold_measures(s, by=["risk_tier"]).select(
                "risk_tier", "selected_threshold", "txns_flagged"
            )
        ),
        "m33_m35_cost_parameters": by_threshold(
            "review_cost_per_case", "false_decline_cost", "recovery_rate"
        ),
    }
    return found


def _slices() -> dict[str, Query]:
    def extract(limit):
        return on_star(lambda s: slices.stratified_extract(s, limit))

    rates = ("fraud_rate_pct", "value_at_risk_pct")
    return {
        "r01_kpi_source": on_fact(lambda fact: digits(slices.kpi_source(fact), 9, *rates)),
        "r02_band": on_fact(slices.band_slice),
        "r03_type": on_fact(slices.type_slice),
        "r04_daily": on_fact(slices.daily_slice),
        "r05_hour": on_fact(slices.hour_slice),
        "r06_watchlist": on_star(lambda s: slices.watchlist(s.terminal)),
        "r06_watchlist_slice": on_star(lambda s: slices.watchlist(s.terminal, 300)),
        "r06_watchlist_top20": on_star(lambda s: slices.watchlist(s.terminal, 20)),
        "r07_segment": on_star(lambda s: slices.segment_slice(s.customer)),
        "r08_threshold_view": on_fact(lambda fact: slices.threshold_view(X.threshold_sweep(fact))),
        "r09_stratified_extract": extract(40_000),
        "r09_stratified_extract_small": extract(2_000),
        "r10_heat_map": on_fact(slices.heat_slice),
        "r10_heat_pivot": on_fact(slices.heat_pivot),
        "r11_amount_histogram": on_fact(
            lambda fact: digits(slices.amount_histogram(fact), 9, "pct_of_class")
        ),
        "r12_pareto_curve": on_star(
            lambda s: digits(slices.pareto_curve(s.terminal), 6, "pct_terminals", "cum_pct")
        ),
        "r12_pareto_readings": on_star(
            lambda s: digits(
                slices.pareto_readings(slices.pareto_curve(s.terminal)), 6, "at_5", "at_10"
            )
        ),
        "r13_portfolio_header": on_fact(
            lambda fact: digits(slices.portfolio_header(slices.daily_slice(fact)), 9, *rates)
        ),
        "r14_headline_shares": on_fact(
            lambda fact: digits(
                slices.headline_shares(slices.type_slice(fact), A.class_summary(fact)),
                9,
                "share_of_incidents_pct",
                "ratio_of_means",
            )
        ),
        "r15_band_levels": on_fact(
            lambda fact: digits(
                slices.band_levels(
                    slices.band_slice(fact), slices.portfolio_header(slices.daily_slice(fact))
                ),
                9,
                "lowest_bands_pct_of_txns",
            )
        ),
        "r16_watchlist_view_top5": on_star(
            lambda s: slices.watchlist_view(slices.watchlist(s.terminal, 30), S.RISK_TIERS[:2], 5)
        ),
        "r16_watchlist_view": on_star(
            lambda s: slices.watchlist_view(slices.watchlist(s.terminal, 300), S.RISK_TIERS[:2])
        ),
        "r17_segment_matrix": on_star(
            lambda s: digits(
                slices.segment_matrix(s),
                9,
                "customer_impact_rate_pct",
                "fraud_rate_pct",
                "risk_lift",
            )
        ),
        "r18_executive_view": on_star(
            lambda s: digits(slices.executive_view(s, SELECTION), 9, *rates)
        ),
        "r19_terminal_table": on_star(lambda s: digits(slices.terminal_table(s), 9, "fraud_rate_pct")),
        "r19_terminal_pareto_top10": on_star(
            lambda s: digits(slices.terminal_pareto_top(s, 10), 9, "cumulative_loss_pct")
        ),
        "r19_terminal_pareto_top": on_star(
            lambda s: digits(slices.terminal_pareto_top(s), 9, "cumulative_loss_pct")
        ),
    }


def queries() -> dict[str, Query]:
    """One entry per operator; each reads the supplied tables of a scale-factor folder."""
    groups = (
        _cleaning,
        _dimensions,
        _round_trips,
        _questions,
        _significance,
        _decisions,
        _measures,
        _slices,
    )
    found = {name: query for group in groups for name, query in group().items()}
    if llm := _optional("txnrisk.llm.queries"):
        found |= llm.queries()
    if pipeline := _optional("corpus_pipeline"):
        found["pipeline"] = pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    """An independent SQL statement for every query that SQL can express."""
    found = build_sql()
    if llm := _optional("txnrisk.llm.sql"):
        found |= llm.oracle_sql()
    if (pipeline := _optional("corpus_pipeline")) and pipeline.ORACLE_SQL:
        found["pipeline"] = pipeline.ORACLE_SQL
    return found


def _optional(module: str):
    """A module of the removable part, or None where that part or anything it needs is missing.

    Any failure to import it leaves the part out, so the other queries stay registered.
    """
    try:
        return importlib.import_module(module)
    except Exception:  # noqa: BLE001 - the removable part is optional as a whole
        return None
