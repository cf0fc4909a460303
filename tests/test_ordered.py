import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.operators import running
from txnrisk.operators.ordered import ntile, position, prefix_sums, quantiles
from txnrisk.operators.running import running_columns


@pytest.fixture(scope="module")
def ties(spark):
    # a third of all rows share one value
    i = F.col("id")
    value = F.when(i % 3 == 0, 5.0).otherwise((i * 31 % 97).cast("double"))
    return spark.range(0, 600, 1, 7).select(i, value.alias("v"))


def test_prefix_sums_match_a_plain_scan(ties):
    sums = {"rows": F.lit(1), "ids": F.col("id")}
    got = prefix_sums(ties, ["-v", "id"], sums, totals=True).collect()
    rows = sorted(ties.collect(), key=lambda r: (-r["v"], r["id"]))
    total, seen = 0, {}
    for place, r in enumerate(rows):
        seen[r["id"]] = (place, total)
        total += r["id"]
    assert len(got) == 600
    for r in got:
        assert (r["rows"], r["ids"]) == seen[r["id"]]
        assert r["rows_total"] == 600 and r["ids_total"] == total


def test_slices_split_a_value_shared_by_many_rows(spark, ties):
    from txnrisk.operators.ordered import SLICE, sliced

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = sliced(ties, ["v", "id"]).where("v = 5.0").select(SLICE).distinct().count()
        assert parts > 1
        test_prefix_sums_match_a_plain_scan(ties)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("n", [1, 3, 5, 7, 23])
def test_ntile_gives_the_larger_tiles_first(spark, n):
    df = spark.range(n).select(F.col("id").alias("p"), F.lit(n).alias("n"))
    got = [r[0] for r in df.orderBy("p").select(ntile(F.col("p"), F.col("n"), 5)).collect()]
    assert got == [t + 1 for t, part in enumerate(np.array_split(range(n), 5)) for _ in part]


def test_position_counts_every_row(ties):
    placed = position(ties, ["v", "id"], "place", total="n")
    assert sorted(r["place"] for r in placed.collect()) == list(range(600))
    assert placed.first()["n"] == 600


def test_quantiles_interpolate_like_numpy(ties):
    points = {"a": 0.25, "b": 0.5, "c": 0.9}
    got = quantiles(ties.withColumn("w", F.col("v") * F.col("id")), "w", points).first()
    values = [r["v"] * r["id"] for r in ties.collect()]
    for name, q in points.items():
        assert got[name] == pytest.approx(np.quantile(values, q), abs=1e-9)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_running_columns_match_a_plain_scan(spark, ties, coalesce):
    keyed = ties.withColumn("k", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 5 + 2))
    columns = {
        "place": running.counted(),
        "before": running.total_before(F.col("id")),
        "prev": running.previous(F.col("v")),
    }
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, coalesce)
    try:
        split = running_columns(keyed, "k", ["v", "id"], columns).collect()
    finally:
        spark.conf.set(setting, before)
    want, state = [], {}
    for r in sorted(keyed.collect(), key=lambda r: (r["k"], r["v"], r["id"])):
        place, total, last = state.get(r["k"], (0, None, None))
        want.append((r["id"], r["v"], r["k"], place + 1, total, last))
        state[r["k"]] = (place + 1, (total or 0) + r["id"], r["v"])
    assert sorted(map(tuple, split), key=str) == sorted(want, key=str)


def test_running_columns_split_a_heavy_key_at_its_cut_points(spark, ties, monkeypatch):
    monkeypatch.setattr(running, "SLICE_ROWS", 10)
    for most in (2_000, 7):  # all cut points, then thinned ones
        monkeypatch.setattr(running, "MOST_CUTS", most)
        keyed = ties.withColumn("k", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 5 + 2))
        cuts = {r["k"]: len(r["_cuts"]) for r in running._cuts(keyed, "k", ["v", "id"]).collect()}
        assert cuts[1] > 1 and sum(cuts.values()) <= 2 * most
        test_running_columns_match_a_plain_scan(spark, ties, "false")


def test_running_columns_leave_out_rows_without_a_key(spark, monkeypatch):
    for step in (50_000, 1):
        monkeypatch.setattr(running, "SLICE_ROWS", step)
        rows = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4)], "k int, v int")
        got = running_columns(rows, "k", ["v"], {"place": running.counted()}).collect()
        assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 2, 2)]


def test_the_star_shuffles_rows_once_per_running_key_and_writes_no_copies(spark, many):
    from txnrisk.operators.features import build_fact
    from txnrisk.sources.workspace import settled

    clean = settled(many)
    built = build_fact(clean)
    assert sorted(built.inputFiles()) == sorted(clean.inputFiles())
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_the_star_shuffles_no_column_that_a_row_gives_by_itself(spark, many):
    from txnrisk.operators.features import build_fact
    from txnrisk.sources.workspace import settled

    plan = build_fact(settled(many))._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Exchange hashpartitioning")
    for name in ("amount_band", "part_of_day", "fraud_type", "txn_hour"):
        assert name in above and name not in below


def test_cut_points_of_several_orders_come_from_one_scan(spark, ties, monkeypatch):
    monkeypatch.setattr(running, "SLICE_ROWS", 10)
    keyed = ties.withColumns({"a": F.col("id") % 3, "b": F.when(F.col("id") % 7 > 0, F.col("id") % 5)})
    scanned = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda i: (scanned.add(1), i)[1], "long").asNondeterministic()
    orders = [("a", ["v", "id"]), ("b", ["id"])]
    drawn = running.cut_rows(keyed.withColumn("id", seen("id")), *orders)
    for key, order in orders:
        alone = running._cuts(keyed.where(F.col(key).isNotNull()), key, order)
        shared = running._cuts(drawn.where(F.col(key).isNotNull()), key, order)
        assert sorted(map(str, shared.collect())) == sorted(map(str, alone.collect()))
    assert scanned.value == 600


def test_slices_are_found_by_bisection(spark):
    """As many comparisons as the number of cut points has binary digits, not one for each."""
    for n in (1, 2, 3, 7, 8, 100):
        rows = spark.range(-3, 2 * n + 3).select(F.lit(1).alias("k"), "id")
        found = spark.range(n).select(F.lit(1).alias("k"), F.struct((2 * F.col("id")).alias("id")).alias("at"))
        cuts = found.groupBy("k").agg(F.sort_array(F.collect_list("at")).alias("_cuts"))
        cuts = running._with_steps(cuts, n + 5)
        assert len(cuts.first()["_steps"]) == n.bit_length()
        got = running._numbered(rows.unionByName(spark.range(1).select(F.lit(2).alias("k"), "id")), cuts, "k", ["id"], "left")
        for r in got.collect():
            assert r["_slice"] == (sum(2 * c <= r["id"] for c in range(n)) if r["k"] == 1 else 0)


def test_ranges_are_contiguous_and_need_no_second_run_of_their_rows(spark, many, monkeypatch):
    from txnrisk.operators.features import time_features
    from txnrisk.sources.workspace import settled

    source = time_features(settled(many))
    order = ["txn_datetime", "transaction_id"]
    for step, cuts, least in ((50_000, 4, 1), (10, 8, 5), (10, 1, 40)):
        monkeypatch.setattr(running, "SLICE_ROWS", step)
        monkeypatch.setattr(running, "RANGE_CUTS", cuts)
        computed = spark.sparkContext.accumulator(0)
        seen = F.udf(lambda i: (computed.add(1), i)[1], "long").asNondeterministic()
        rows = source.withColumn("transaction_id", seen("transaction_id"))
        dealt = running.in_ranges(rows, "date_key", order, source)
        parts = dealt.select(F.spark_partition_id().alias("p"), "date_key", *order).collect()
        assert computed.value == len(parts) == 900
        in_order = [r["p"] for r in sorted(parts, key=lambda r: (r["date_key"], r["txn_datetime"], r["transaction_id"]))]
        assert in_order == sorted(in_order) and len(set(in_order)) >= least


def test_every_order_statistic_is_the_same_in_many_slices(spark, star):
    from txnrisk.operators import dims, measures as M, significance as A
    from txnrisk.plans import customers, slices

    def results():
        frames = [
            dims.build_dim_customer(star.fact),
            A.class_summary(star.fact),
            A.mann_whitney(star.fact),
            M.terminal_pareto(star),
            customers.triage_list(star.customer),
            slices.pareto_curve(star.terminal),
        ]
        return [sorted(map(str, f.collect())) for f in frames]

    plain = results()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert results() == plain
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
