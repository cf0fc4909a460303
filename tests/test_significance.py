import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.operators import significance as A


@pytest.fixture(scope="module")
def classes(star):
    rows = star.fact.select(F.col("amount").cast("double"), "is_fraud").collect()
    bad = np.array([r[0] for r in rows if r[1] == 1])
    good = np.array([r[0] for r in rows if r[1] == 0])
    return bad, good


def test_class_summary(star, classes):
    bad, good = classes
    got = A.class_summary(star.fact).first()
    assert got["median_fraud"] == pytest.approx(np.median(bad))
    assert got["median_legit"] == pytest.approx(np.median(good))
    assert got["ratio_of_means"] == pytest.approx(bad.mean() / good.mean())


def test_skewness_is_the_population_form(star, classes):
    got = {r["is_fraud"]: r["skew"] for r in A.skew_by_class(star.fact).collect()}
    for flag, x in ((1, classes[0]), (0, classes[1])):
        assert got[flag] == pytest.approx(((x - x.mean()) ** 3).mean() / x.std() ** 3)


def test_mann_whitney_matches_pair_counting(spark):
    bad, good = [1.0, 2.0, 2.0, 5.0, 9.0], [2.0, 3.0, 1.0, 5.0, 5.0, 8.0, 0.5]
    made = [(v, 1) for v in bad] + [(v, 0) for v in good]
    fact = spark.createDataFrame(made, "a double, is_fraud int").withColumn("amount", F.col("a").cast("decimal(12,2)"))
    u = sum((x > y) + 0.5 * (x == y) for x in bad for y in good)
    got = A.mann_whitney(fact).first()
    assert got["u_statistic"] == u
    assert got["effect_size_rank_biserial"] == pytest.approx(abs(1 - 2 * u / 35))
    # ties: 1 twice, 2 three times, 5 three times
    ties = 6 + 24 + 24
    sigma = math.sqrt(35 / 12 * (13 - ties / (12 * 11)))
    z = (max(u, 35 - u) - 17.5 - 0.5) / sigma
    assert got["p_value"] == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))))


def test_chi_square_corrects_two_by_two_tables(spark):
    made = [("a", 1)] * 12 + [("a", 0)] * 5 + [("b", 1)] * 3 + [("b", 0)] * 9
    got = A.chi_square(spark.createDataFrame(made, "k string, is_fraud int"), "k").first()
    observed = np.array([[12, 5], [3, 9]])
    expected = observed.sum(1, keepdims=True) * observed.sum(0) / observed.sum()
    gap = np.abs(observed - expected)
    assert got["chi2"] == pytest.approx(((gap - np.minimum(gap, 0.5)) ** 2 / expected).sum())
    assert got["dof"] == 1


def test_chi_square_p_equals_the_ml_test(spark, star):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    coded = star.fact.select(F.substring("amount_band", 1, 2).cast("int").alias("x"), "is_fraud")
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(coded)
    ml = ChiSquareTest.test(rows, "features", "is_fraud").first()
    got = A.chi_square(star.fact, "amount_band").first()
    assert got["chi2"] == pytest.approx(ml["statistics"][0])
    assert got["p_value"] == pytest.approx(ml["pValues"][0], abs=1e-9)
    assert got["dof"] == ml["degreesOfFreedom"][0]


def test_normality_rejects_skewed_and_accepts_normal_quantiles(spark):
    rng = np.random.default_rng(7)
    normal = rng.normal(50, 10, 4000)
    made = [(float(round(v, 2)), 0) for v in normal]
    fact = spark.createDataFrame(made, "a double, is_fraud int").withColumn("amount", F.col("a").cast("decimal(12,2)"))
    assert A.normality(fact, draws=None).first()["p_value"] > 0.01
    squared = fact.withColumn("amount", (F.col("a") * F.col("a")).cast("decimal(12,2)"))
    assert A.normality(squared, draws=None).first()["p_value"] < 1e-6


@pytest.mark.parametrize("draws", [1, 500])
def test_the_number_of_draws_is_exact(spark, star, draws):
    assert A.normality(star.fact, draws=draws).first()["n"] == draws
    two = star.fact.where("is_fraud = 0").limit(2)
    assert A._drawn(two, F.col("amount").alias("_x"), draws, 1).count() == draws
    assert A._drawn(two.limit(0), F.col("amount").alias("_x"), draws, 1).count() == 0


def test_an_empty_class_has_no_effect_size(star):
    got = A.mann_whitney(star.fact.where("is_fraud = 0")).first()
    assert got["effect_size_rank_biserial"] is None and got["p_value"] is None


def test_sampled_normality_is_reproducible(star):
    assert A.normality(star.fact, draws=500).first() == A.normality(star.fact, draws=500).first()


def test_wilson_stays_inside_zero_and_one(spark):
    none = spark.createDataFrame([("a", 0)] * 20 + [("b", 1)] * 20, "k string, is_fraud int")
    rows = {r["k"]: r for r in A.wilson_interval(none, by=["k"]).collect()}
    assert rows["a"]["ci_lower_pct"] == pytest.approx(0, abs=1e-9) and rows["a"]["ci_upper_pct"] > 0
    assert rows["b"]["ci_upper_pct"] == pytest.approx(100, abs=1e-9)
