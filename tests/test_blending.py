"""Calibration, blending and flow on small cases with known answers."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.operators import blending, calibration


def test_scores_equal_the_integral():
    x = np.linspace(-40, 60, 200001)
    for mu, sigma, y, cut in [(3.0, 2.0, 5.0, False), (3.0, 2.0, 5.0, True), (0.5, 1.0, 0.2, True)]:
        cdf = calibration.normal_cdf((x - mu) / sigma)
        if cut:
            zero = calibration.normal_cdf(np.array([-mu / sigma]))[0]
            cdf = np.where(x < 0, 0, (cdf - zero) / (1 - zero))
        want = ((cdf - (x >= y)) ** 2).sum() * (x[1] - x[0])
        assert float(calibration.crps(np.array([mu]), np.array([sigma]), np.array([y]), cut)[0]) == pytest.approx(want, abs=2e-3)


def test_the_fit_finds_a_linear_bias(spark):
    rng = np.random.default_rng(0)
    mean, noise = rng.normal(10, 4, 400), rng.normal(0, 1, 400)
    rows = [("a", float(m), 1.0, float(2 + 0.8 * m + e)) for m, e in zip(mean, noise, strict=True)] + [("b", 1.0, 1.0, None), ("b", 2.0, 1.0, 2.0)]
    got = {r.k: r for r in calibration.fit(spark.createDataFrame(rows, "k string, mean double, var double, truth double"), ["k"]).collect()}
    assert got["a"].beta == pytest.approx(0.8, abs=0.05) and got["a"].alpha == pytest.approx(2, abs=0.5)
    assert got["a"].gamma ** 2 + got["a"].delta ** 2 == pytest.approx(1, abs=0.2)
    assert (got["b"].alpha, got["b"].beta, got["b"].gamma, got["b"].delta) == (0.0, 1.0, 0.0, 1.0)


def test_probabilities_of_exceeding(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    got = [r.p for r in df.select(calibration.exceedance(F.col("a"), F.col("b"), 0.5).alias("p")).collect()]
    assert got[0] == pytest.approx(1 - NormalDist(1, 2).cdf(0.5)) and got[1] == 1.0 and (got[2] is None or math.isnan(got[2]))


def test_flow_follows_a_shift():
    y, x = np.mgrid[:40, :40]
    field = lambda dx, dy: 20 + 5 * np.sin((x - dx) / 5) + 5 * np.cos((y - dy) / 6)
    found = blending.flow([field(0, 0)], [field(0.4, -0.2)], 8, change=0.01, fewest=20)
    assert found and all(u == pytest.approx(0.4, abs=0.05) and v == pytest.approx(-0.2, abs=0.05) for _, _, u, v in found)


def test_blends():
    rng = np.random.default_rng(2)
    rain = rng.random((16, 16)) * 10 + 1
    assert np.allclose(blending.skill_blend(0, levels=4)(rain, rain[::-1]), rain, rtol=1e-3)
    assert np.allclose(blending.saliency(np.full((9, 9), 3.0)), 0)


def test_pairs_need_both_sides(spark):
    a = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0), (2, 0, 0, 1.0)], "id int, iy int, ix int, value double")
    got = blending.per_pair(a, a.where("id = 1"), "id", lambda p, q: p + q).collect()
    assert sorted((r.id, r.ix, r.value) for r in got) == [(1, 0, 2.0), (1, 1, 4.0)]
