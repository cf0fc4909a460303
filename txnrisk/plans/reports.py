"""The whole run: raw daily files in, star schema, audit, slices and test results out."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from txnrisk.operators import quality, thresholds as X
from txnrisk.plans import slices
from txnrisk.plans.report import statistical_results
from txnrisk.plans.star import Star, build_star
from txnrisk.sources import files
from txnrisk.sources.workspace import run_folder, settled


def report_slices(star: Star) -> dict[str, DataFrame]:
    """Every pre-aggregated slice a dashboard reads; five of them from one written roll-up."""
    totals = settled(X.sweep_totals(star.fact))
    cube = settled(slices.fine_rollup(star.fact))
    return {
        "agg_band": slices.band_slice(star.fact, cube=cube),
        "agg_daily": slices.daily_slice(star.fact, cube=cube),
        "agg_type": slices.type_slice(star.fact),
        "agg_hour": slices.hour_slice(star.fact, cube=cube),
        "agg_heatmap": slices.heat_slice(star.fact, cube=cube),
        "agg_segment": slices.segment_slice(star.customer),
        "top_terminals": slices.watchlist(star.terminal, 300),
        "pareto": slices.pareto_curve(star.terminal),
        "thresholds": X.threshold_sweep(star.fact, totals=totals),
        "sensitivity": X.sensitivity(star.fact, totals=totals),
        "amount_hist": slices.amount_histogram(star.fact, cube=cube),
    }


def run(raw: DataFrame, folder: str, quarantine: bool = False) -> Star:
    """Build the star under ``folder`` and write audit, CSV twins, slices and results beside it.

    Intermediate tables live in one run folder, which is dropped at the end. With ``quarantine``
    rows that do not convert go to ``<folder>/quarantine`` instead of stopping the run.
    """
    with run_folder(raw.sparkSession):
        aside = f"{folder}/quarantine" if quarantine else None
        star = build_star(raw, f"{folder}/star_schema", quarantine=aside)
        renamed = quality.rename_and_prune(raw)
        typed = quality.typed_with_quarantine(renamed)[0] if quarantine else quality.typed(renamed)
        files.write_csv(quality.audit(typed), f"{folder}/data_quality_audit")
        for name, table in star.tables().items():
            files.write_csv(table, f"{folder}/csv/{name}")
        for name, table in report_slices(star).items():
            files.write_csv(table, f"{folder}/slices/{name}")
        files.write_json(statistical_results(star.fact), f"{folder}/slices/stats")
    return star


def main() -> None:
    """``spark-submit`` entry: ``--raw`` folder of daily files, ``--out`` target folder."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--raw", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--quarantine", action="store_true", help="set aside rows that do not convert")
    options = parser.parse_args()
    spark = SparkSession.builder.appName("txnrisk").getOrCreate()
    run(files.read_daily_files(spark, options.raw, options.format), options.out, options.quarantine)
    spark.stop()


if __name__ == "__main__":
    main()
