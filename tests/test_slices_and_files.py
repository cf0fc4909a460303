from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.operators import quality, thresholds as X
from txnrisk.plans import slices
from txnrisk.plans.report import statistical_results
from txnrisk.plans.star import VIEW, Star, build_star, enriched, open_star, register_view
from txnrisk.sources import files, landing
from txnrisk.streaming.landing import land_stream


def as_set(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def raw(many):
    back = {new: old for old, new in quality.RENAMES.items()}
    out = many.withColumnsRenamed(back).select(S.RAW.fieldNames())
    return out.withColumn("TX_AMOUNT", F.col("TX_AMOUNT").cast("double"))


def test_daily_average_uses_the_rounded_rate(spark):
    made = [(20240101 + d, int(i == 0)) for d in range(3) for i in range(7)]
    fact = spark.createDataFrame(made, "date_key int, is_fraud int").withColumn("amount", F.lit(1).cast("decimal(12,2)"))
    got = slices.daily_slice(fact).collect()
    assert {r["fraud_rate_7d_ma"] for r in got} == {14.286}


def test_histogram_is_left_closed_and_open_ended(clean_frame):
    fact = clean_frame([(i, "2024-03-01 10:00:00", 1, 1, a, 0) for i, a in enumerate(["9.99", "10.00", "599.99", "600.00"])])
    got = {r["bin"]: r["n"] for r in slices.amount_histogram(fact).collect()}
    assert got == {0: 1, 10: 1, 590: 1}


@pytest.mark.parametrize("limit", [1, 50, 333, 5000])
def test_extract_is_exact_and_reproducible(star, limit):
    got = slices.stratified_extract(star, limit)
    legit = star.fact.where("is_fraud = 0").count()
    assert got.where("is_fraud = 1").count() == star.fact.where("is_fraud = 1").count()
    assert got.where("is_fraud = 0").count() == min(limit, legit)
    moved = replace(star, fact=star.fact.repartition(5))
    again = slices.stratified_extract(moved, limit)
    assert as_set(got.select("transaction_id")) == as_set(again.select("transaction_id"))


def test_pareto_reaches_all_loss(star):
    curve = slices.pareto_curve(star.terminal).orderBy("pct_terminals").collect()
    assert curve[-1]["pct_terminals"] == 100.0 and curve[-1]["cum_pct"] == 100.0
    assert [r["cum_pct"] for r in curve] == sorted(r["cum_pct"] for r in curve)


def test_watchlist_view_without_choice_means_all(star):
    listed = slices.watchlist(star.terminal, 300)
    assert slices.watchlist_view(listed).count() == listed.count()
    assert slices.watchlist_view(listed, ["nowhere"]).count() == 0


def test_threshold_view_is_inclusive(star):
    got = [r["threshold"] for r in slices.threshold_view(X.threshold_sweep(star.fact)).collect()]
    assert got[0] == 100 and got[-1] == 400 and len(got) == 31


def test_heat_pivot_has_every_band(star):
    assert slices.heat_pivot(star.fact).columns == ["part_of_day"] + [f"band_0{i}" for i in range(1, 8)]


def test_report_is_one_nested_row(star, tmp_path, spark):
    result = statistical_results(star.fact)
    files.write_json(result, str(tmp_path / "r"))
    back = files.read_json(spark, str(tmp_path / "r"), result.schema).collect()
    assert len(back) == 1
    assert len(back[0]["test6_sensitivity"]["scenarios"]) == 9
    assert back[0]["test7_blind_spot"]["threshold"] == back[0]["test5_threshold"]["optimal_threshold"]


def test_star_round_trip(spark, raw, star, tmp_path):
    built = build_star(raw, str(tmp_path / "star"))
    for name, df in open_star(spark, str(tmp_path / "star")).tables().items():
        assert as_set(df) == as_set(star.tables()[name].select(df.columns)), name
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in S.TABLES[name]]
    view = register_view(built)
    assert len(view.columns) == 18 and spark.table(VIEW).count() == 900


def test_star_without_day_folders_is_equal(raw, star, tmp_path):
    built = build_star(raw, str(tmp_path / "star"), daily_folders=False)
    assert as_set(built.fact) == as_set(star.fact)


def test_only_days_present_are_replaced(spark, star, tmp_path):
    target = str(tmp_path / "fact")
    files.write_fact(star.fact, target)
    day = star.fact.agg(F.min("date_key")).first()[0]
    changed = star.fact.where(F.col("date_key") == day).withColumn("txn_hour", F.lit(99))
    files.write_fact(changed.select(S.FACT.fieldNames()), target)
    back = files.read_fact(spark, target)
    assert back.count() == 900
    assert {r[0] for r in back.where("txn_hour = 99").select("date_key").distinct().collect()} == {day}


def test_csv_keeps_types_and_microseconds(spark, star, tmp_path):
    for name, df in star.tables().items():
        files.write_csv(df, str(tmp_path / name))
        assert as_set(files.read_csv(spark, str(tmp_path / name), S.TABLES[name])) == as_set(df.select(S.TABLES[name].fieldNames()))


def test_csv_that_breaks_its_schema_fails(spark, tmp_path):
    spark.createDataFrame([("x", "y")], "date_key string, date string").write.option("header", True).csv(str(tmp_path / "d"))
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "d"), S.DIM_DATE).collect()


def test_daily_scan_orders_duplicates_by_file(spark, raw, tmp_path):
    inbox = str(tmp_path / "in")
    first = raw.where("TRANSACTION_ID <= 10").withColumn("TX_AMOUNT", F.lit(1.0)).coalesce(1)
    second = raw.where("TRANSACTION_ID <= 10").withColumn("TX_AMOUNT", F.lit(2.0)).coalesce(1)
    first.write.parquet(f"{inbox}/day=1")
    second.write.parquet(f"{inbox}/day=2")
    kept = quality.clean(files.read_daily_files(spark, inbox)).collect()
    assert len(kept) == 10 and {float(r["amount"]) for r in kept} == {1.0}


def test_landing_skips_days_it_has(spark, raw, tmp_path):
    target = str(tmp_path / "land")
    landing.land_new_days(raw, target)
    landing.land_new_days(raw, target)
    assert landing.read_landed(spark, target).count() == 900
    later = raw.withColumn("TX_DATETIME", F.expr("TX_DATETIME + INTERVAL 40 DAYS"))
    landing.land_new_days(raw.unionByName(later), target)
    assert landing.read_landed(spark, target).count() == 1800


def test_replacing_days_leaves_the_others(spark, raw, tmp_path):
    target = str(tmp_path / "land")
    landing.replace_days(raw, target)
    first_day = raw.where(F.col("TX_DATETIME") < F.lit("2024-03-02").cast("timestamp_ntz"))
    changed = first_day.withColumn("TX_AMOUNT", F.lit(0.5))
    for _ in range(2):
        landing.replace_days(changed, target)
    back = landing.read_landed(spark, target)
    assert back.count() == 900
    assert back.where("TX_AMOUNT = 0.5").count() == first_day.count()


def test_stream_takes_each_file_once(spark, raw, tmp_path):
    inbox, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    raw.where("TRANSACTION_ID % 2 = 0").write.parquet(f"{inbox}/a")
    land_stream(spark, inbox, target, log)
    assert landing.read_landed(spark, target).count() == 450
    raw.where("TRANSACTION_ID % 2 = 1").write.parquet(f"{inbox}/b")
    land_stream(spark, inbox, target, log)
    land_stream(spark, inbox, target, log)
    assert landing.read_landed(spark, target).count() == 900


def test_stream_batch_stream_share_one_log(spark, raw, tmp_path, monkeypatch):
    inbox, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    early = raw.where(F.col("TX_DATETIME") < F.lit("2024-03-10").cast("timestamp_ntz"))
    late = raw.where(F.col("TX_DATETIME") >= F.lit("2024-03-10").cast("timestamp_ntz"))
    early.write.parquet(f"{inbox}/a")
    land_stream(spark, inbox, target, log)
    landing.land_new_days(raw, target)  # adds the later days only
    assert landing.read_landed(spark, target).count() == 900
    late.where("TRANSACTION_ID % 3 = 0").write.parquet(f"{inbox}/b")  # rows the batch landed already
    land_stream(spark, inbox, target, log)
    assert landing.read_landed(spark, target).count() == 900
    # a stream batch killed after its rows, before its manifest rows, then run again
    extra = late.withColumn("TRANSACTION_ID", F.col("TRANSACTION_ID") + 10_000)
    real_write = landing._write

    def rows_only(dated, folder, tag=None):
        monkeypatch.setattr(landing, "MANIFEST", "_not_the_manifest")
        try:
            real_write(dated, folder, tag)
        finally:
            monkeypatch.setattr(landing, "MANIFEST", "_landed")
        raise RuntimeError("killed before the manifest")

    monkeypatch.setattr(landing, "_write", rows_only)
    with pytest.raises(RuntimeError):
        landing.land_batch(extra, target, "stream-9")
    monkeypatch.setattr(landing, "_write", real_write)
    landing.land_batch(extra, target, "stream-9")
    landing.land_batch(extra, target, "stream-9")
    back = landing.read_landed(spark, target)
    assert back.count() == 900 + late.count()
    assert back.select("TRANSACTION_ID").distinct().count() == 900 + late.count()
    logged = landing.commit_log(spark, target)
    assert logged.filter("tag = 'stream-9'").count() == late.select(F.to_date("TX_DATETIME")).distinct().count()


def test_whole_run_writes_every_output(spark, raw, star, tmp_path):
    import os

    from txnrisk.plans.reports import run

    run(raw, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["csv", "data_quality_audit", "slices", "star_schema"]
    assert len(os.listdir(tmp_path / "out" / "slices")) == 12
    daily = slices.daily_slice(star.fact)
    as_text = daily.withColumn("txn_date", F.col("txn_date").cast("string"))
    back = files.read_slice(spark, str(tmp_path / "out" / "slices" / "agg_daily"), as_text.schema)
    assert as_set(back) == as_set(daily)


def test_bucketed_tables_join_without_moving_the_fact(spark, star, tmp_path):
    from txnrisk.plans.star import open_published, publish

    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/wh'")
    publish(star, "bucketed", customer_buckets=4)
    stored = open_published(spark, "bucketed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = stored.fact.join(stored.customer, "customer_id").groupBy("value_segment").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(customer_id") == 0 and "SortMergeJoin" in plan
        assert sum(r["count"] for r in joined.collect()) == 900
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_are_published_at_the_same_time_with_their_statistics(spark, star, tmp_path, monkeypatch):
    import threading

    from pyspark.sql import DataFrameWriter

    from txnrisk.plans.star import publish

    everyone, save = threading.Barrier(5), DataFrameWriter.saveAsTable

    def meet(self, *args, **options):
        everyone.wait(timeout=60)  # breaks unless all five tables are being written
        return save(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", meet)
    spark.sql(f"CREATE DATABASE published LOCATION '{tmp_path}/wh'")
    try:
        publish(star, "published")
        for name, df in star.tables().items():
            told = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED published.{name}").collect()}
            assert f"{df.count()} rows" in told["Statistics"]
            for column in df.columns:
                facts = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED published.{name} {column}").collect()}
                assert facts["distinct_count"] != "NULL"
        assert as_set(spark.table(f"published.{VIEW}")) == as_set(enriched(star))
    finally:
        spark.sql("DROP DATABASE published CASCADE")


def test_five_slices_read_the_roll_up_not_the_fact(spark, star):
    from txnrisk.sources.workspace import settled

    cube = settled(slices.fine_rollup(star.fact))
    fact_files = set(star.fact.inputFiles())
    made = [
        slices.band_slice(star.fact, cube=cube),
        slices.daily_slice(star.fact, cube=cube),
        slices.hour_slice(star.fact, cube=cube),
        slices.heat_slice(star.fact, cube=cube),
        slices.amount_histogram(star.fact, cube=cube),
    ]
    for df in made:
        assert not fact_files & set(df.inputFiles())
    for with_cube, alone in zip(made, [slices.band_slice(star.fact), slices.daily_slice(star.fact), slices.hour_slice(star.fact),
                                       slices.heat_slice(star.fact), slices.amount_histogram(star.fact)]):
        assert with_cube.collect() == alone.collect()


def test_terminal_copy_reads_few_row_groups(spark, star, tmp_path):
    import glob

    import pyarrow.parquet as pq

    def groups_touched(folder, wanted):
        touched = total = 0
        for path in glob.glob(f"{folder}/**/*.parquet", recursive=True):
            meta = pq.ParquetFile(path).metadata
            at = meta.schema.to_arrow_schema().get_field_index("terminal_id")
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                total += 1
                touched += any(stats.min <= t <= stats.max for t in wanted)
        return touched, total

    by_terminal, by_day = str(tmp_path / "t"), str(tmp_path / "d")
    files.write_terminal_copy(star.fact, by_terminal, row_group_bytes=1024)
    star.fact.orderBy("txn_datetime").write.option("parquet.block.size", "1024").parquet(by_day)
    wanted = [5, 9]
    t_touched, t_total = groups_touched(by_terminal, wanted)
    d_touched, d_total = groups_touched(by_day, wanted)
    assert t_total > 4 and t_touched / t_total < 0.5 < d_touched / d_total
    got = files.read_fact(spark, by_terminal).where(F.col("terminal_id").isin(wanted))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, star.fact.where(F.col("terminal_id").isin(wanted)).collect()))


def test_the_event_adapter_parses_each_json_value_once(spark, tmp_path):
    from txnrisk.operators import quality
    from txnrisk.sources.sample_tables import events_as_raw

    spark.sql(
        """SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' AS ts, id AS user_id, 'error' AS event_type,
        double(id) AS value, CASE WHEN id < 3 THEN concat('{"k": ', id + 22, '}') END AS props FROM range(4)"""
    ).write.parquet(f"{tmp_path}/events.parquet")
    raw = events_as_raw(spark, str(tmp_path))
    rows = {r["TRANSACTION_ID"]: (r["TERMINAL_ID"], r["TX_FRAUD"], r["TX_FRAUD_SCENARIO"]) for r in raw.collect()}
    assert rows == {0: (22, 0, 0), 1: (23, 1, 2), 2: (24, 0, 0), 3: (None, 0, 0)}
    for made in (raw, quality.clean(raw)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1
