"""Published results replayed from published counts."""

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import significance as A, thresholds as X

# fixed values: rows and frauds per label, published
PERIODS = {
    "01 Night (00-06)": (113224, 900),
    "02 Morning (06-12)": (328036, 2591),
    "03 Afternoon (12-18)": (327851, 2551),
    "04 Evening (18-24)": (113357, 891),
}
BANDS = {
    "01 Micro (0-25)": (261953, 1296),
    "02 Small (25-50)": (222333, 1188),
    "03 Medium (50-100)": (278724, 1697),
    "04 Large (100-200)": (116646, 1049),
    "05 High (200-220)": (1186, 77),
    "06 Very High (220-500)": (1334, 1334),
    "07 Extreme (500+)": (292, 292),
}
# threshold, flagged, caught, false alarms, prevented, operating, residual, net
SWEEP_ROWS = [
    (20, 672619, 5902, 666717, 687423.24, 10018461.0, 11263.51, -9342301.27),
    (30, 571466, 5389, 566077, 677838.69, 8507322.0, 24042.91, -7853526.22),
    (40, 480610, 4910, 475700, 665231.76, 7150230.0, 40852.15, -6525850.39),
    (50, 398248, 4451, 393797, 649796.79, 5920308.0, 61432.11, -5331943.32),
]
TOTAL_LOSS = 927827.83


def expanded(spark, counts, name):
    """One row per transaction from label counts."""
    cells = [(k, f, n) for k, (rows, bad) in counts.items() for f, n in ((1, bad), (0, rows - bad)) if n]
    df = spark.createDataFrame(cells, f"{name} string, is_fraud int, n int")
    return df.select(name, "is_fraud", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).drop("i")


def test_counts_agree():
    assert sum(n for n, _ in PERIODS.values()) == sum(n for n, _ in BANDS.values()) == 882468
    assert sum(b for _, b in PERIODS.values()) == sum(b for _, b in BANDS.values()) == 6933


def test_timing_shows_no_effect(spark):
    got = A.chi_square(expanded(spark, PERIODS, "part_of_day"), "part_of_day").first()
    assert got["chi2"] == pytest.approx(0.43830474433621214, rel=1e-9)
    assert got["p_value"] == pytest.approx(0.9322207660278953, abs=1e-9)
    assert got["cramers_v"] == pytest.approx(0.0007047557092800743, rel=1e-9)
    assert (got["dof"], got["significant_at_5pct"], got["practical_significance"]) == (3, False, "weak")


def test_amount_band_is_strong_but_has_a_thin_cell(spark):
    got = A.chi_square(expanded(spark, BANDS, "amount_band"), "amount_band").first()
    assert got["chi2"] == pytest.approx(206430.80663124434, rel=1e-9)
    assert got["cramers_v"] == pytest.approx(0.48365732749432805, rel=1e-9)
    assert got["min_expected"] == pytest.approx(2.29, abs=0.005)
    assert (got["strength"], got["valid"], got["p_value"]) == ("STRONG", False, 0.0)


def test_rates_by_period(spark):
    got = {r[0]: r[1] for r in A.rate_by(expanded(spark, PERIODS, "part_of_day")).collect()}
    assert list(got.values()) == [0.795, 0.79, 0.778, 0.786]


def test_wilson_interval(spark):
    got = A.wilson_interval(expanded(spark, {"all": (882468, 6933)}, "k")).first()
    assert got["point_estimate_pct"] == pytest.approx(0.7856375528631067, abs=1e-12)
    assert got["ci_lower_pct"] == pytest.approx(0.7674302677737217, abs=1e-9)
    assert got["ci_upper_pct"] == pytest.approx(0.8042733047676982, abs=1e-9)


def test_cost_model_identity(spark):
    made = [(t, n, c, round(p / 0.75 * 100), round(TOTAL_LOSS * 100)) for t, n, c, _, p, *_ in SWEEP_ROWS]
    frame = spark.createDataFrame(
        made, "threshold int, flagged long, caught long, caught_cents long, fraud_cents long"
    )
    model = X.net_benefit(F.lit(3.0), F.lit(12.0), F.lit(0.75))
    got = frame.select("threshold", *[v.alias(k) for k, v in model.items()]).collect()
    for r, (t, _, _, _, prevented, operating, residual, net) in zip(got, SWEEP_ROWS):
        assert r["threshold"] == t and r["operating"] == operating
        assert r["prevented"] == pytest.approx(prevented, abs=0.01)
        assert r["missed"] == pytest.approx(residual, abs=0.02)
        assert r["net"] == pytest.approx(net, abs=0.03)


def test_rank_biserial_from_the_published_u():
    n1, n2 = 6933, 882468 - 6933
    assert abs(1 - 2 * 4028340808.5 / (n1 * n2)) == pytest.approx(0.3272767578293978, abs=1e-12)
