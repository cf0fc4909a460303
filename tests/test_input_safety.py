"""Columns bound by name, text ids, bad values, landing that can be repeated, and owned intermediates."""

import os

import pytest
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.operators import measures as M, quality
from txnrisk.plans import portfolio
from txnrisk.plans.star import star_for
from txnrisk.sources import files, landing, workspace

HEADER = "TRANSACTION_ID,TX_DATETIME,TERMINAL_ID,CUSTOMER_ID,TX_AMOUNT,TX_FRAUD,TX_FRAUD_SCENARIO"
ROWS = ["1,2024-01-01T00:00:01,70,5,10.5,0,0", "2,2024-01-01T00:00:02,71,6,20.25,1,1"]


def daily_csv(folder, *rows, header=HEADER, name="a"):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.csv").write_text("\n".join([header, *rows]) + "\n")
    return str(folder)


def cleaned(rows):
    return {r["transaction_id"]: r for r in quality.clean(rows).collect()}


def test_daily_csv_is_bound_by_header(spark, tmp_path):
    got = cleaned(files.read_daily_files(spark, daily_csv(tmp_path / "d", *ROWS), "csv"))
    assert (got[1]["customer_id"], got[1]["terminal_id"], float(got[2]["amount"])) == (5, 70, 20.25)


def test_files_in_another_order_are_bound_by_their_own_header(spark, tmp_path):
    folder = daily_csv(tmp_path / "d", *ROWS)
    other = HEADER.replace("TERMINAL_ID,CUSTOMER_ID", "CUSTOMER_ID,TERMINAL_ID")
    daily_csv(tmp_path / "d", "3,2024-01-01T00:00:03,7,72,1,0,0", header=other, name="b")
    got = cleaned(files.read_daily_files(spark, folder, "csv"))
    assert (got[1]["customer_id"], got[1]["terminal_id"]) == (5, 70)
    assert (got[3]["customer_id"], got[3]["terminal_id"]) == (7, 72)


def test_days_with_number_and_text_ids(spark, many, tmp_path):
    names = dict(zip(quality.CLEAN_COLUMNS, S.RAW.fieldNames()))
    raw = many.select(*[F.col(c).alias(n) for c, n in names.items()]).withColumn("TX_AMOUNT", F.col("TX_AMOUNT").cast("double"))
    day = F.to_date("TX_DATETIME")
    first = raw.agg(F.min(day)).first()[0]
    as_text = raw.where(day > first).withColumns({c: F.col(c).cast("string") for c in ("CUSTOMER_ID", "TERMINAL_ID")})
    files.write_daily_files(raw.where(day == first), str(tmp_path / "d"))
    files.write_daily_files(as_text, str(tmp_path / "d"))
    got = quality.clean(files.read_daily_files(spark, str(tmp_path / "d")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quality.clean(raw).collect()))


def test_typed_csv_is_bound_by_header(spark, tmp_path):
    folder = daily_csv(tmp_path / "d", "3,100", header="fraud_txns,txns")
    schema = "txns long, fraud_txns long"
    got = files.read_csv(spark, folder, spark.createDataFrame([], schema).schema).first()
    assert (got["txns"], got["fraud_txns"]) == (100, 3)


@pytest.mark.parametrize("bad", ["1,2024-01-01T00:00:01,70,5,5x0,0,0", "1,yesterday,70,5,5,0,0"])
def test_bad_values_stop_or_are_set_aside(spark, tmp_path, bad):
    raw = files.read_daily_files(spark, daily_csv(tmp_path / "d", ROWS[1], bad), "csv")
    with pytest.raises(Exception, match="bad "):
        quality.clean(raw).collect()
    kept, aside = quality.typed_with_quarantine(quality.rename_and_prune(raw))
    assert [r["transaction_id"] for r in kept.collect()] == [2]
    assert [r["transaction_id"] for r in aside.collect()] == ["1"]


def test_a_run_can_set_rows_aside_and_drops_its_intermediates(spark, tmp_path):
    from txnrisk.plans.reports import run

    lines = [f"{i},2024-01-{i % 28 + 1:02}T0{i % 9}:00:00,{i % 7},{i % 11},{i % 90 + i / 100 + 1},{i % 2},{i % 2 * (i % 3 + 1)}" for i in range(300)]
    raw = files.read_daily_files(spark, daily_csv(tmp_path / "d", *lines, "900,2024-01-01T00:00:00,1,1,x,0,0"), "csv")
    shared = workspace.shared_folder(spark).removeprefix("file:")
    before = {p for p, _, _ in os.walk(shared)}
    star = run(raw, str(tmp_path / "out"), quarantine=True)
    assert star.fact.count() == 300
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 1
    left = {p for p, _, _ in os.walk(shared)} - before
    assert not [p for p in left if "step" in p or "run-" in p]


def test_text_ids_in_parquet(spark, many, tmp_path):
    names = dict(zip(quality.CLEAN_COLUMNS, S.RAW.fieldNames()))
    raw = many.select(*[F.col(c).alias(n) for c, n in names.items()]).withColumn("TX_AMOUNT", F.col("TX_AMOUNT").cast("double"))
    as_text = raw.withColumns({c: F.col(c).cast("string") for c in ("CUSTOMER_ID", "TERMINAL_ID")})
    files.write_daily_files(as_text, str(tmp_path / "d"))
    got = quality.clean(files.read_daily_files(spark, str(tmp_path / "d")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quality.clean(raw).collect()))


def raw_rows(spark, *rows):
    made = [(i, t, 1, 1, 1.0, 0, 0) for i, t in rows]
    frame = spark.createDataFrame(made, "TRANSACTION_ID long, t string, CUSTOMER_ID long, TERMINAL_ID long, TX_AMOUNT double, TX_FRAUD int, TX_FRAUD_SCENARIO int")
    return frame.withColumn("TX_DATETIME", F.col("t").cast("timestamp_ntz")).select(S.RAW.fieldNames())


def landed(spark, folder):
    return sorted(r["TRANSACTION_ID"] for r in landing.read_landed(spark, folder).collect())


def test_landing_repeats_with_null_times(spark, tmp_path):
    folder = str(tmp_path / "landed")
    raw = raw_rows(spark, (1, "2024-01-01 10:00:00"), (2, None), (3, "2024-01-02 10:00:00"))
    for _ in range(3):
        landing.land_new_days(raw, folder)
        assert landed(spark, folder) == [1, 2, 3]
    landing.replace_days(raw_rows(spark, (9, None)), folder)
    assert landed(spark, folder) == [1, 3, 9]


def test_a_day_that_a_broken_run_left_half_written_is_landed_again(spark, tmp_path):
    folder = str(tmp_path / "landed")
    half = raw_rows(spark, (1, "2024-01-01 10:00:00")).withColumn("date_key", landing.landing_day())
    half.write.partitionBy("date_key").parquet(folder)  # rows without an entry in the manifest
    landing.land_new_days(raw_rows(spark, (1, "2024-01-01 10:00:00"), (2, "2024-01-01 11:00:00")), folder)
    assert landed(spark, folder) == [1, 2]


def test_the_star_follows_its_source(spark, tmp_path):
    def source(s, folder):
        return s.read.parquet(folder)

    folder = str(tmp_path / "src")
    raw_rows(spark, *[(i, f"2024-01-01 10:00:{i:02}") for i in range(9)]).withColumn(
        "CUSTOMER_ID", F.col("TRANSACTION_ID")
    ).withColumn("TX_AMOUNT", F.col("TRANSACTION_ID") + 1.0).write.parquet(folder)
    first = star_for(source, spark, folder)
    assert star_for(source, spark, folder) is first
    raw_rows(spark, (50, "2024-01-02 10:00:00")).write.mode("append").parquet(folder)
    assert star_for(source, spark, folder).fact.count() == first.fact.count() + 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_distinct_count_copies_the_fact(star):
    from txnrisk.plans import slices

    for df in (portfolio.totals(star.fact), portfolio.loss_by_type(star.fact), slices.kpi_source(star.fact)):
        assert "Expand" not in plan_of(df)


def test_measures_meet_dimensions_after_rolling_up(star):
    """Below every join with a dimension the fact is an aggregate."""
    frames = [
        M.threshold_measures(star, (100, 200), by=["risk_tier"]),
        M.evaluate(star, ["terminals_affected", "customers_affected"], by=["value_segment"]),
    ]
    for df in frames:
        lines = plan_of(df).splitlines()
        for i, line in enumerate(lines):
            if "Join" in line:
                depth = len(line) - len(line.lstrip(" :+-"))
                below = [x for x in lines[i + 1 :] if len(x) - len(x.lstrip(" :+-")) > depth]
                fact = next(k for k, x in enumerate(below) if "is_fraud" in x and "Relation" in x or "terminal_txn_seq" in x)
                assert any("Aggregate" in x for x in below[:fact])


def test_no_local_fallback_on_a_cluster(spark, tmp_path):
    from txnrisk.sources import workspace as W

    W._refuse_private(spark, f"file:{tmp_path}", "local[8]")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        W._refuse_private(spark, f"file:{tmp_path}", "spark://cluster:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        W._refuse_private(spark, str(tmp_path), "yarn")


def test_owners_are_per_thread(spark):
    import threading

    from txnrisk.sources import workspace as W

    seen = {}

    def run(name):
        with W.run_folder(spark) as folder:
            seen[name] = (folder, W.fresh_path(spark, "x"))

    threads = [threading.Thread(target=run, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(path.startswith(folder) for folder, path in seen.values())
    assert seen["a"][0] != seen["b"][0]


def test_independent_steps_run_at_the_same_time(spark):
    import threading

    both, folders = threading.Barrier(2), []

    def step():
        both.wait(timeout=60)  # breaks unless the other step runs too
        folders.append(os.path.dirname(workspace.fresh_path(spark, "step")))

    with workspace.run_folder(spark) as folder:
        workspace.together(spark, step, step)
        assert folders == [folder, folder]

    def bad():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        workspace.together(spark, bad, lambda: None)
