"""Exact numbers of rows without a window over them, and what depends on it; draws that no partitioning changes; small samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortgraph.operators import cohort, network, stats
from cohortgraph.operators.lineage import placed


def test_places_in_one_hot_group_and_others(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 3 == 0 else "a" if k % 3 == 1 else f"g{k % 50}", int(x)) for k, x in enumerate(rng.permutation(1500))]
    got = placed(spark.createDataFrame(rows, "g string, x int").repartition(7), ["g"], [F.desc("x")], total="n").collect()
    for g in {r[0] for r in rows}:
        own = sorted((x for k, x in rows if k == g), reverse=True)
        assert sorted((r.place, r.x) for r in got if r.g == g) == list(enumerate(own)) and all(r.n == len(own) for r in got if r.g == g)
    whole = placed(spark.createDataFrame(rows, "g string, x int").repartition(5), [], ["x"]).collect()
    assert sorted((r.place, r.x) for r in whole) == list(enumerate(sorted(x for _, x in rows)))
    assert placed(spark.createDataFrame([], "g string, x int"), ["g"], ["x"]).count() == 0


def test_draws_do_not_depend_on_the_cluster(spark):
    """The mixture's threshold is the same however many tasks run at once: its parts are fixed."""
    first = network.mixture_threshold(spark, 4, 0.3, 0.5, 20_000, 7)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert network.mixture_threshold(spark, 4, 0.3, 0.5, 20_000, 7) == first
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_shapiro_of_published_weights():
    """Weights of eleven men; W and p as published."""
    w, p = stats.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.79, abs=2e-3) and p == pytest.approx(0.0067, abs=3e-4)


@pytest.mark.parametrize("n", range(3, 12))
def test_small_samples_of_normal_values_have_uniform_p(n):
    rng = np.random.default_rng(n)
    p = np.sort([stats.shapiro_wilk(rng.normal(size=n))[1] for _ in range(3000)])
    assert np.abs(p - (np.arange(3000) + 0.5) / 3000).max() < 0.04
    skewed = [stats.shapiro_wilk(rng.exponential(size=n) ** 2)[1] for _ in range(500)]
    assert np.mean(np.array(skewed) < 0.05) > 0.08


def test_three_values():
    assert stats.shapiro_wilk([0, 1, 2]) == pytest.approx((1.0, 1.0)) and stats.shapiro_wilk([0, 0, 5]) == pytest.approx((0.75, 0.0), abs=1e-6)


def test_significant_components_are_numbered_without_gaps(spark):
    labelled = spark.createDataFrame([(1, 2, 3), (2, 3, 3), (5, 6, 8), (9, 10, 12), (10, 11, 12)], "i int, j int, component int")
    tests = spark.createDataFrame([(3, 0.2), (8, 0.01), (12, 0.04)], "component int, p double")
    assert sorted(tuple(r[c] for c in ("i", "j", "component")) for r in network.significant_components(labelled, tests).collect()) == [(5, 6, 1), (9, 10, 2), (10, 11, 2)]
    assert network.significant_components(labelled, tests.where("p > 1")).count() == 0


def test_crosstab_and_counts(spark):
    rows = spark.createDataFrame([("x", 0)] * 10 + [("x", 1)] * 20 + [("y", 0)] * 20 + [("y", 1)] * 10, "a string, b int")
    (r,) = cohort.crosstab_test(cohort.crosstab(rows, "a", "b"), "a", "b").collect()
    assert r.chi2 == pytest.approx(60 * (10 * 10 - 20 * 20) ** 2 / 30**4) and r.df == 1 and r.p == pytest.approx(0.009823, abs=1e-5)
    p = spark.createDataFrame([("m", 0.01), ("m", 0.2), ("k", 0.5), ("m", None)], "measure string, p double")
    assert {x.measure: x.n for x in stats.counts_below(p, ["measure"], 0.05).collect()} == {"m": 1, "k": 0}
